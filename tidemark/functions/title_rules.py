"""Issuer announcement titles: which event a title announces, if any.

Rules are tried in order, the more specific stage of a process before the
broader one. Titles must be NFKC-normalised and free of white space. ``sample``
is a title that the rule, and none before it, must tell.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TitleRule:
    id: str
    code: str
    pattern: str
    excluded: str | None = None
    sample: str = ""


# Fixed value: titles that deny, doubt or only report on something.
NEGATED = r"(?:传闻不实|不属实|不存在|予以澄清|澄清(?:公告|说明)?|网传|网络传闻|网页消息|网页报道|媒体报道|新闻报道|市场消息|中标候选人|中标候选|候选中标|预中标|入围|未(?:最终|正式)?中标|尚未(?:最终|正式)?中标|中标失败|落标)|中标意向|意向中标|拟中标|尚待(?:签署|签订).*(?:合同|协议)|尚未(?:签署|签订).*(?:合同|协议)|(?:尚未|没有|未|不)(?:能|再)?(?:最终|正式|明确)?(?:获得|取得|获批|获|核准|批准|同意注册|审议通过|发布|披露|完成|完毕|实施完成|终止|停止|实施|授予|签署|签订|收到|发生|受理|被?立案调查|达到|降至|变更|辞职|辞任|下调|注销|除权|除息)"

# Fixed value: titles that revise or withdraw something.
REVISED = r"(?:更正(?:公告|说明)?|修订(?:稿|版|公告)?|更新版?|补充公告|补充说明|撤回|撤销|取消)"

# A revision that is itself the event, and what it must not contain.
REVISED_BUYBACK = r"回购股份.*修订|修订.*回购股份"
NOT_REVISED_BUYBACK = r"(?:撤回|撤销|取消|更正|补充)"

# Provider column codes that name an event.
COLUMN_CODES = {
    "001002004001": "event.financial_results.earnings_forecast_published",
    "001002004002": "event.financial_results.earnings_flash_report",
    "001002007003009001002": "event.repurchase_capital.repurchase_change",
    "001001001001001": "event.financial_results.annual_report",
    "001001001002001": "event.financial_results.semiannual_report",
    "001001001003001": "event.financial_results.quarterly_report",
    "001001001004001": "event.financial_results.quarterly_report",
}

# Id, event code, pattern and exclusion of each rule, in the order in which they are tried.
ISSUER_TITLES = (
    TitleRule("cash-dividend-ex-date-v1", "event.dividends_corporate_actions.cash_dividend_ex_date",
              r"(?:现金红利|现金股利).*(?:发放日|派发日|除息日)|(?:发放|派发)(?:现金红利|现金股利).*(?:实施|公告)",
              sample="公司发放现金红利实施公告"),
    TitleRule("cash-dividend-approved-v1", "event.dividends_corporate_actions.cash_dividend_approved",
              r"(?:现金分红|派发现金红利).*(?:股东大会审议通过|获批)|(?:股东大会审议通过|获批).*(?:现金分红|派发现金红利)",
              sample="股东大会审议通过现金分红方案的公告"),
    TitleRule("cash-dividend-proposal-v1", "event.dividends_corporate_actions.cash_dividend_proposal",
              r"(?:现金分红|派发现金红利).*(?:预案|方案)",
              r"(?:实施|发放日|派发日|除息)",
              sample="2023年度现金分红预案公告"),
    TitleRule("stock-dividend-ex-date-v1", "event.dividends_corporate_actions.stock_dividend_ex_date",
              r"(?:送股|送红股).*(?:实施|除权)",
              sample="2022年度送股实施公告"),
    TitleRule("stock-dividend-proposal-v1", "event.dividends_corporate_actions.stock_dividend_proposal",
              r"(?:送股|送红股).*(?:预案|方案)",
              r"(?:实施|除权)",
              sample="2023年度送红股预案公告"),
    TitleRule("capitalization-issue-v1", "event.dividends_corporate_actions.capitalization_issue",
              r"资本公积(?:金)?转增(?:股本|股份).*(?:实施|完成)",
              sample="资本公积金转增股本实施公告"),
    TitleRule("rights-issue-v1", "event.dividends_corporate_actions.rights_issue",
              r"配股.*(?:发行公告|实施公告|结果公告)",
              sample="2021年度配股发行公告"),
    TitleRule("unlock-schedule-change-v1", "event.restricted_shares_pledges.unlock_schedule_change",
              r"(?:限售股|限售股份|解除限售).*(?:日期|安排).*(?:变更|调整|延期)|(?:变更|调整|延期).*(?:限售股|限售股份).*(?:上市流通|解禁)",
              sample="关于变更限售股份上市流通时间的公告"),
    TitleRule("restricted-shares-unlock-v1", "event.restricted_shares_pledges.restricted_shares_unlock",
              r"(?:限售股|限售股份|首次公开发行前已发行股份).*(?:解禁|上市流通)|解除限售.*上市流通",
              r"(?:变更|调整|延期|取消)",
              sample="首次公开发行前已发行股份上市流通提示性公告"),
    TitleRule("actual-controller-change-v1", "event.shareholder_holdings.actual_controller_change",
              r"实际控制人(?:发生)?变更|变更实际控制人",
              sample="关于公司实际控制人发生变更的公告"),
    TitleRule("ownership-below-five-percent-v1", "event.shareholder_holdings.ownership_below_five_percent",
              r"持股(?:比例)?.*(?:降至|低于|不足)5%|权益变动.*5%以下",
              sample="股东持股比例降至5%的提示性公告"),
    TitleRule("ownership-reaches-five-percent-v1", "event.shareholder_holdings.ownership_reaches_five_percent",
              r"持股(?:比例)?.*(?:达到|增至|超过)5%|权益变动.*达到5%",
              sample="股东持股比例达到5%的提示性公告"),
    TitleRule("executive-decrease-v1", "event.shareholder_holdings.executive_decrease",
              r"(?:董监高|董事、监事、高级管理人员|董事|监事|高级管理人员).*(?:减持|卖出)",
              r"(?:拟减持|减持股份(?:的)?预披露|减持计划(?:预披露|公告)$)",
              sample="关于董事减持股份的公告"),
    TitleRule("executive-increase-v1", "event.shareholder_holdings.executive_increase",
              r"(?:董监高|董事、监事、高级管理人员|董事|监事|高级管理人员).*(?:增持|买入)",
              r"(?:拟增持|增持股份(?:的)?预披露|增持计划(?:预披露|公告)$)",
              sample="关于高级管理人员增持公司股份的公告"),
    TitleRule("major-holder-decrease-progress-v1", "event.shareholder_holdings.major_holder_decrease_progress",
              r"(?:持股5%以上(?:的)?股东|大股东|控股股东|实际控制人).*减持.*(?:进展|完成|完毕|结果)",
              sample="控股股东减持股份进展公告"),
    TitleRule("major-holder-decrease-plan-v1", "event.shareholder_holdings.major_holder_decrease_plan",
              r"(?:持股5%以上(?:的)?股东|大股东|控股股东|实际控制人).*减持.*(?:计划|预披露)",
              r"(?:进展|完成|完毕|结果|终止)",
              sample="控股股东减持股份计划公告"),
    TitleRule("major-holder-increase-progress-v1", "event.shareholder_holdings.major_holder_increase_progress",
              r"(?:持股5%以上(?:的)?股东|大股东|控股股东|实际控制人).*增持.*(?:进展|完成|完毕|结果)",
              sample="大股东增持股份结果公告"),
    TitleRule("major-holder-increase-plan-v1", "event.shareholder_holdings.major_holder_increase_plan",
              r"(?:持股5%以上(?:的)?股东|大股东|控股股东|实际控制人).*增持.*(?:计划|拟增持)",
              r"(?:进展|完成|完毕|结果|终止)",
              sample="控股股东增持股份计划公告"),
    TitleRule("repurchase-termination-v1", "event.repurchase_capital.repurchase_termination",
              r"(?:终止|停止).*回购|回购.*(?:终止|停止)",
              r"不(?:终止|停止)",
              sample="关于终止回购公司股份的公告"),
    TitleRule("repurchase-cancellation-v1", "event.repurchase_capital.repurchase_cancellation",
              r"(?:注销|完成注销).*(?:已回购|回购)股份|回购股份.*注销",
              sample="关于完成注销已回购股份的公告"),
    TitleRule("repurchase-change-v1", "event.repurchase_capital.repurchase_change",
              r"(?:调整|变更).*回购股份.*(?:方案|用途|价格|数量)|回购股份.*(?:方案|用途|价格|数量).*(?:调整|变更)",
              sample="关于调整回购股份价格上限的公告"),
    TitleRule("repurchase-first-execution-v1", "event.repurchase_capital.repurchase_first_execution",
              r"首次(?:实施)?回购.*股份|首次回购公司股份",
              sample="关于首次回购公司股份的公告"),
    TitleRule("repurchase-completion-v1", "event.repurchase_capital.repurchase_completion",
              r"回购股份.*(?:实施结果|实施完成|完成公告)|完成回购.*股份",
              r"(?:注销|终止|停止)",
              sample="关于回购股份实施结果的公告"),
    TitleRule("repurchase-progress-v1", "event.repurchase_capital.repurchase_progress",
              r"回购股份.*(?:进展|比例达到)|回购.*进展公告",
              sample="关于回购股份进展情况的公告"),
    TitleRule("repurchase-approved-v1", "event.repurchase_capital.repurchase_approved",
              r"股东大会.*(?:审议通过|批准).*回购|回购.*(?:股东大会审议通过|获股东大会批准)",
              sample="股东大会审议通过回购议案的公告"),
    TitleRule("repurchase-proposal-v1", "event.repurchase_capital.repurchase_proposal",
              r"回购(?:公司)?股份.*(?:预案|方案)|关于回购(?:公司)?股份的公告",
              r"(?:进展|首次|实施结果|完成|注销|终止|停止|调整|变更|股东大会审议通过)",
              sample="关于回购公司股份方案的公告"),
    TitleRule("equity-incentive-grant-v1", "event.governance_personnel.equity_incentive_grant",
              r"(?:股权|限制性股票|股票期权)激励计划.*(?:首次授予|预留授予|授予登记|授予完成)|向.*授予.*(?:限制性股票|股票期权)",
              r"(?:归属|行权|解锁|解除限售)",
              sample="限制性股票激励计划首次授予公告"),
    TitleRule("equity-incentive-plan-v1", "event.governance_personnel.equity_incentive_plan",
              r"(?:股权|限制性股票|股票期权)激励计划.*(?:草案|方案)",
              r"(?:首次授予|预留授予|授予登记|授予完成)",
              sample="2023年股票期权激励计划草案"),
    TitleRule("public-censure-v1", "event.regulation_risk.public_censure",
              r"公开谴责(?:决定书)?|受到公开谴责",
              sample="关于受到公开谴责的公告"),
    TitleRule("disciplinary-action-v1", "event.regulation_risk.disciplinary_action",
              r"纪律处分(?:决定书)?|受到纪律处分",
              sample="关于受到纪律处分的公告"),
    TitleRule("administrative-penalty-v1", "event.regulation_risk.administrative_penalty",
              r"行政处罚决定书|收到行政处罚",
              r"事先告知",
              sample="关于收到行政处罚决定书的公告"),
    TitleRule("investigation-opened-v1", "event.regulation_risk.investigation_opened",
              r"(?:收到)?立案告知书|被立案调查|监管立案调查",
              sample="关于公司被立案调查的公告"),
    TitleRule("information-disclosure-violation-v1", "event.regulation_risk.information_disclosure_violation",
              r"信息披露(?:违法违规|违规)(?:认定|决定|结论)",
              sample="信息披露违规认定公告"),
    TitleRule("litigation-progress-v1", "event.litigation_credit.litigation_progress",
              r"(?:重大诉讼|诉讼事项).*(?:进展|判决|裁决|结果)",
              sample="关于诉讼事项进展的公告"),
    TitleRule("major-litigation-v1", "event.litigation_credit.major_litigation",
              r"(?:涉及|新增|发生)?重大诉讼",
              r"(?:进展|判决|裁决|结果)",
              sample="关于涉及重大诉讼的公告"),
    TitleRule("arbitration-v1", "event.litigation_credit.arbitration",
              r"重大仲裁|涉及仲裁事项",
              r"(?:进展|裁决|结果)",
              sample="关于涉及仲裁事项的公告"),
    TitleRule("debt-default-v1", "event.litigation_credit.debt_default",
              r"(?:债务|贷款|债券).*(?:逾期|违约|未能按期兑付)|未能按期兑付.*(?:债券|本息)",
              sample="关于公司债券违约的公告"),
    TitleRule("credit-rating-downgrade-v1", "event.litigation_credit.credit_rating_downgrade",
              r"(?:主体|债项|信用)评级.*(?:下调|调降)|评级下调",
              sample="关于主体信用评级下调的公告"),
    TitleRule("bankruptcy-reorganization-v1", "event.litigation_credit.bankruptcy_reorganization",
              r"(?:申请|受理|进入).*(?:破产重整|破产清算)|(?:破产重整|破产清算).*(?:申请|受理|进展)",
              sample="关于法院受理公司破产重整申请的公告"),
    TitleRule("chairman-change-v1", "event.governance_personnel.chairman_change",
              r"董事长.*(?:辞职|辞任|离任|变更|选举|选定)|(?:选举|选定|变更).*董事长",
              sample="关于董事长辞职的公告"),
    TitleRule("ceo-change-v1", "event.governance_personnel.ceo_change",
              r"总经理.*(?:辞职|辞任|离任|变更)|(?:聘任|任命|变更).*总经理",
              r"副总经理|总经理助理",
              sample="关于聘任总经理的公告"),
    TitleRule("cfo-change-v1", "event.governance_personnel.cfo_change",
              r"(?:财务负责人|财务总监).*(?:辞职|辞任|离任|变更)|(?:聘任|任命|变更).*(?:财务负责人|财务总监)",
              sample="关于财务总监离任的公告"),
    TitleRule("board-secretary-change-v1", "event.governance_personnel.board_secretary_change",
              r"董事会秘书.*(?:辞职|辞任|离任|变更)|(?:聘任|任命|变更).*董事会秘书",
              sample="关于聘任董事会秘书的公告"),
    TitleRule("director-resignation-v1", "event.governance_personnel.director_resignation",
              r"(?:董事|独立董事).*(?:辞职|辞任)",
              r"(?:董事长|董事会秘书)",
              sample="关于独立董事辞职的公告"),
    TitleRule("supervisor-resignation-v1", "event.governance_personnel.supervisor_resignation",
              r"监事.*(?:辞职|辞任)",
              sample="关于监事辞职的公告"),
    TitleRule("restructuring-terminated-v1", "event.m_and_a_restructuring.restructuring_terminated",
              r"终止.*(?:重大资产重组|发行股份购买资产)|(?:重大资产重组|发行股份购买资产).*终止",
              sample="关于终止重大资产重组的公告"),
    TitleRule("restructuring-completed-v1", "event.m_and_a_restructuring.restructuring_completed",
              r"(?:重大资产重组|发行股份购买资产).*(?:实施完成|交割完成)|(?:实施完成|交割完成).*(?:重大资产重组|发行股份购买资产)",
              sample="关于重大资产重组实施完成的公告"),
    TitleRule("restructuring-regulatory-approval-v1", "event.m_and_a_restructuring.restructuring_regulatory_approval",
              r"(?:重大资产重组|发行股份购买资产).*(?:获|取得).*(?:证监会|交易所).*(?:同意|批准|注册)|(?:证监会|交易所).*(?:同意|批准|注册).*(?:重大资产重组|发行股份购买资产)",
              sample="关于重大资产重组获得证监会批准的公告"),
    TitleRule("restructuring-shareholder-approval-v1", "event.m_and_a_restructuring.restructuring_approved_shareholders",
              r"股东大会.*审议通过.*(?:重大资产重组|发行股份购买资产)|(?:重大资产重组|发行股份购买资产).*股东大会审议通过",
              sample="股东大会审议通过重大资产重组的公告"),
    TitleRule("restructuring-board-approval-v1", "event.m_and_a_restructuring.restructuring_approved_board",
              r"董事会.*审议通过.*(?:重大资产重组|发行股份购买资产)|(?:重大资产重组|发行股份购买资产).*董事会审议通过",
              sample="董事会审议通过发行股份购买资产的公告"),
    TitleRule("restructuring-resumption-v1", "event.m_and_a_restructuring.restructuring_resumption",
              r"(?:重大资产重组|筹划重组).*复牌|复牌.*(?:重大资产重组|筹划重组)",
              sample="关于筹划重组复牌的公告"),
    TitleRule("restructuring-suspension-v1", "event.m_and_a_restructuring.restructuring_suspension",
              r"(?:重大资产重组|筹划重组).*停牌|停牌.*(?:重大资产重组|筹划重组)",
              sample="重大资产重组停牌公告"),
    TitleRule("spin-off-listing-v1", "event.m_and_a_restructuring.spin_off_listing",
              r"分拆.*上市",
              sample="关于分拆子公司上市的公告"),
    TitleRule("asset-sale-plan-v1", "event.m_and_a_restructuring.asset_sale_plan",
              r"(?:重大资产出售|出售重大资产).*(?:预案|方案)",
              sample="重大资产出售预案"),
    TitleRule("acquisition-plan-v1", "event.m_and_a_restructuring.acquisition_plan",
              r"(?:发行股份购买资产|重大资产收购|收购重大资产).*(?:预案|方案)",
              sample="发行股份购买资产预案"),
    TitleRule("major-contract-terminated-v1", "event.contracts_orders.contract_terminated",
              r"(?:重大合同|重大经营合同).*(?:终止|解除)|(?:终止|解除).*(?:重大合同|重大经营合同)",
              sample="关于终止重大合同的公告"),
    TitleRule("major-contract-changed-v1", "event.contracts_orders.contract_changed",
              r"(?:重大合同|重大经营合同).*(?:变更|调整)|(?:变更|调整).*(?:重大合同|重大经营合同)",
              sample="关于重大合同变更的公告"),
    TitleRule("major-contract-completed-v1", "event.contracts_orders.contract_completed",
              r"(?:重大合同|重大经营合同).*(?:履行完毕|完成履行|完成交付)",
              sample="关于重大经营合同履行完毕的公告"),
    TitleRule("major-contract-progress-v1", "event.contracts_orders.contract_progress",
              r"(?:重大合同|重大经营合同).*(?:进展|履行情况)",
              sample="关于重大合同履行情况的公告"),
    TitleRule("major-contract-won-v1", "event.contracts_orders.major_contract_won",
              r"重大项目.*(?:中标|中选)|(?:中标|中选).*重大项目",
              sample="关于重大项目中标的公告"),
    TitleRule("major-contract-signed-v1", "event.contracts_orders.major_contract_signed",
              r"(?:签署|签订).*(?:重大合同|重大经营合同)|(?:重大合同|重大经营合同).*(?:签署|签订)",
              sample="关于签订重大合同的公告"),
    TitleRule("framework-agreement-v1", "event.contracts_orders.framework_agreement",
              r"(?:签署|签订).*(?:战略合作|框架)协议|(?:战略合作|框架)协议.*(?:签署|签订)",
              sample="关于签署战略合作协议的公告"),
    TitleRule("major-order-received-v1", "event.contracts_orders.purchase_order_received",
              r"(?:收到|获得|取得).*重大订单|重大订单.*(?:收到|获得|取得)",
              sample="关于收到重大订单的公告"),
)
